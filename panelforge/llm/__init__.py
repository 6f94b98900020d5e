"""Training-data operators: an optional subpackage that nothing else imports."""
