"""repeatloom: tandem-repeat analytics and text-table operators on Spark DataFrames."""
