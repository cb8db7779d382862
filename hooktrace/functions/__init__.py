"""Column functions: URLs, dates, IP numbers, field cleaning and the risk score."""
