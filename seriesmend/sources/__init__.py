"""Reading tables, finding the time axis, opening variables and annotations."""
