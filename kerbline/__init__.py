"""Trajectory safety and energy analytics, expressed as Spark DataFrame operators."""

from kerbline.params import Params

__all__ = ["Params"]
