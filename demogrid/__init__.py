"""demogrid: gridded-population analytics as Spark DataFrame operators."""

from .model import Between, GridSpec, In, Question, Registry, Variable

__all__ = ["Between", "GridSpec", "In", "Question", "Registry", "Variable"]
