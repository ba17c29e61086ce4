"""Video-corpus analytics as plain DataFrame-to-DataFrame functions on Spark."""

from reelgauge.session import configure, shared_dir

__all__ = ["configure", "shared_dir"]
