"""veilspark: detection, pseudonymisation and restoration of personal data as Spark DataFrame operators."""
