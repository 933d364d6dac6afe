"""Models that an audit calls but does not hold: embedding networks, whole-image radiomics, registration."""
