"""Permit screening of onsite power plants at portfolio scale, as Spark DataFrame jobs."""
