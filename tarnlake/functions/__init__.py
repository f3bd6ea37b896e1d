from .scalars import days_between, null_count, percent

__all__ = ["days_between", "null_count", "percent"]
