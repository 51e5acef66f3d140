"""The workloads, composed of operators."""
