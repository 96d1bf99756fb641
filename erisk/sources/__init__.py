"""Tables, nested records, model parameters and reports."""
