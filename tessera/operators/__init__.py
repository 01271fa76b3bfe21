"""DataFrame -> DataFrame operators, grouped by topic.

``ordering``     positions, ntile, ranks, exact quantiles without one-task windows
``joins``        enrich, semi/anti, reconcile, tier/range lookup, interval, as-of, carry_forward
``aggregates``   summaries, rollup, cube, grouping sets, distinct, pivot, unpivot, top-n, set ops
``cleaning``     profile, key checks, orphans, dedupe, duplicates, safe cast, impute, outliers
``timeseries``   forward fill, period change, moving / trailing windows, calendar
``customers``    cohorts, retention, funnel, sessions, active users, LTV, RFM, ABC
``experiments``  A/B counts, z / Welch / chi-square tests, sample ratio, bootstrap
``vectors``      centroids and cosine similarity on array columns
``sizing``       size-checked broadcast
"""
