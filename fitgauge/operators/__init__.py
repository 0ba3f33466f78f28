"""DataFrame operators: candidates, profiles, scores, reports."""
