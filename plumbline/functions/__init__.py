"""Column functions: angles, geodesy, sentence text, covariance forms."""
