"""The SQL dialect: lexer, syntax tree and parser."""

from .parser import parse, parse_single

__all__ = ["parse", "parse_single"]
