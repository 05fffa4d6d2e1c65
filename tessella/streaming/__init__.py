"""Extensions over event streams."""
