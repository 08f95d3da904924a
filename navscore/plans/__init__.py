"""The eleven reports and the daily / weekly runs built from the operators."""
