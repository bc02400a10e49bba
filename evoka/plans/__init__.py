"""Stages composed of the operators."""
