from .publish import publish
from .quality import profile_all

__all__ = ["profile_all", "publish"]
