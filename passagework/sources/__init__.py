"""Files, jobs and tables as inputs and outputs."""
