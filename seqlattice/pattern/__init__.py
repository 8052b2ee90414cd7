"""Row-pattern queries: model, text front end and variable graph."""
