"""Per-customer features, selection and scoring for raw transaction tables."""
