"""Promotion-lift measurement as lazy Spark DataFrame jobs."""

from promolift.config import LiftConfig
from promolift.plans.model import LiftModel, Tables
from promolift.session import build_session

__all__ = ["LiftConfig", "LiftModel", "Tables", "build_session"]
