"""All check queries."""

from . import behaviour, features, forest_walk, models, policy_checks, requests, resume, streams, trained  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
