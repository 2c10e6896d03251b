"""plumbline: ranked, sourced and audited analytics over periodic reports, on Spark DataFrames."""
