"""Multi-dimensional image stacks as Spark relations: pixels are rows, planes and volumes are keys."""

__version__ = "0.1.0"
