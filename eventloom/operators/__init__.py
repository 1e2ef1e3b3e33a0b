"""Query operators over an event log: DataFrame in, DataFrame out."""
