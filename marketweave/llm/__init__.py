"""Training-data operators: ten independent modules plus their query registry.

Nothing outside this subpackage imports it; deleting the folder leaves the
market-analytics engine intact.
"""
