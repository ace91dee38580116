"""Part of the stratum library."""
