"""Prepare, check and score reasoning-distillation training data on Spark."""
