"""Empty on purpose: this workload has no unbounded source."""
