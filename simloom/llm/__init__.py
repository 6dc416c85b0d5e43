"""Operators for preparing large text corpora; nothing else in simloom imports this subpackage."""
