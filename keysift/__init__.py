"""keysift: find hard-coded credentials in very large text collections with Spark.

Everything is a DataFrame in, DataFrame out.  ``plans.scan`` strings the
operators together; each operator can also be used on its own.
"""

from keysift.options import ScanOptions
from keysift.plans.scan import detect, scan

__version__ = "1.0.0"

__all__ = ["ScanOptions", "detect", "scan", "__version__"]
