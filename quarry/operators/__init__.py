"""DataFrame → DataFrame operators (profiles, distributions, tests, imputation, sampling)."""
