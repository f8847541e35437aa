"""Column functions shared by parsers and rules."""
