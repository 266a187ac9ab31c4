"""factloom: build and query a knowledge base of text facts on Spark."""
