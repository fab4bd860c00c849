"""Column expressions shared by training, exploration and scoring."""
