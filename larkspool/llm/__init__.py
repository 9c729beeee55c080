"""Training-data operators; a self-contained subpackage nothing else imports."""
