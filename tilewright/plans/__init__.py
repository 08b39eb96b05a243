"""The registered queries of the grid, signal and quality operators, with the SQL that checks them."""
