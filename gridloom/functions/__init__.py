"""Element-wise functions of tensors."""
