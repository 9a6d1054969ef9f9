"""Build, perturb, split, profile and fairness-audit client-partitioned tables on Spark."""
