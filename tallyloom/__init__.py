"""tallyloom: reconciliation analytics and corpus preparation as Spark plans."""
