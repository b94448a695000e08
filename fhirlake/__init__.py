"""Clinical record analytics on PySpark: bundles -> flat records -> bronze -> silver -> reports."""
