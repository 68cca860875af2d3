"""cueflow: corpus-scale analysis of timed, bilingual text on Spark."""

from cueflow.session import get_session

__all__ = ["get_session"]
