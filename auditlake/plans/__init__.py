"""Rule catalogue, verdicts and gates."""
