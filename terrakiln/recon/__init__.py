"""Geometry that needs one building's points together: numpy inside grouped Arrow functions."""
