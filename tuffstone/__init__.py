"""tuffstone: content and supply-chain analytics on Spark DataFrames."""
