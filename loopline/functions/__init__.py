"""Column expression libraries; every function returns a Column."""
