"""Scalar functions of the expression language, as Column builders."""
