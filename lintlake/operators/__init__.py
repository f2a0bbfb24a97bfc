"""DataFrame operators: facts, rules, findings, scores, comparison, reports, reviews."""
