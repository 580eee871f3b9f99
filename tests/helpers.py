"""Small helpers of the tests."""

from collections import Counter


def rows(df, *columns):
    """The rows of a frame as a multiset of tuples."""
    return Counter(map(tuple, (df.select(*columns) if columns else df).collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
