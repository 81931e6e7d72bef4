"""bucketscope: object-inventory listings and analytics as Spark DataFrame operators."""

from bucketscope.operators.filters import FilterConfig
from bucketscope.plans.display import Display
from bucketscope.plans.listing import bucket_listing, listing

__all__ = ["Display", "FilterConfig", "bucket_listing", "listing"]
