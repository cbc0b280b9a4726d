"""DataFrame operators: every one returns a plan, none runs a job."""
