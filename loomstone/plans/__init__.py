"""Views, questions and the guarded query plane."""
