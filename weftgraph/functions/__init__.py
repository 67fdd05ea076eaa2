"""Value semantics and expressions over bound variables."""
