"""Dataflow operators: table-agnostic building blocks and the reconciliation stages made of them."""
