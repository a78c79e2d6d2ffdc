"""DataFrame operators: profile, treat, encode, transform, recommend, select, model, evaluate, label."""
