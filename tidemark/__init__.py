"""Evidence resolution and reorganisation planning over asset inventories, on Spark."""
