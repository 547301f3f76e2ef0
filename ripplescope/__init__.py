"""Change-to-test selection and coverage analytics on Spark DataFrames."""
