"""Plan and run data migrations between systems whose tables refer to each other.

Catalog side: scope, layout, dependency order and load plan of a whole fleet of
environments, every table keyed by ``org_key``.  Data side: staging, key maps,
lookup resolution, deferred updates, record waves and resets.
"""
