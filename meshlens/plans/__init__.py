"""Views, panel queries and the batch capture job."""
