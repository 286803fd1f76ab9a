"""Part of logweft; see the modules."""
