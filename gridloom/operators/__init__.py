"""Operators on tensors beyond element-wise expressions."""
