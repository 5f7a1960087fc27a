"""A fetch function for the tests: a candle every minute, newest first, and some around the range."""


def minutes(symbol, granularity, start, end, options):
    first = start - start % granularity - 2 * granularity
    return [[at, 1.0, 2.0, 1.5, 1.75, 10.0] for at in range(end + 2 * granularity, first, -granularity)]
