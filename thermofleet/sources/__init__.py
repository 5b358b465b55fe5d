"""Reading landed files into typed tables, and writing tables back."""
