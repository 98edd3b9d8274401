"""Requests and the plans that answer them."""
