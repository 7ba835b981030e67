"""Trajectory analytics and corpus preparation as composable Spark DataFrame operators."""
