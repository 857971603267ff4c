"""selvedge: shipment documents to reconciled, validated tables, as Spark DataFrames."""
