"""Closed formulas of sizing, leverage, costs and statistics; they take numbers or Columns where no branch is needed.

Normal quantiles are constants of the plan (``NormalDist``); the normal distribution function of a Column is native.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def normal_cdf(z: Column) -> Column:
    """Hart's rational approximation in Graeme West's form; absolute error about 1e-15."""
    a = F.abs(z)
    top = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    low = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

    def poly(c):
        out = F.lit(c[0])
        for x in c[1:]:
            out = out * a + x
        return out

    inner = F.exp(-a * a / 2) * poly(top) / poly(low)
    cont = F.lit(0.65)
    for k in (4, 3, 2, 1):
        cont = F.lit(float(k)) / (a + cont)
    outer = F.exp(-a * a / 2) / ((a + cont) * 2.506628274631)
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, inner).otherwise(outer)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


# --- sizing -----------------------------------------------------------------------------------------------------------
def kelly_fraction(mu, sigma):
    return mu / (mu * mu + sigma * sigma)


def kelly_fraction_highvol(sharpe, sigma):
    return sharpe / sigma


def kelly_binary(p, win, loss):
    return p / loss - (1 - p) / win


def fractional_kelly(mu, sigma, fraction):
    return fraction * kelly_fraction(mu, sigma)


def kelly_growth_rate(sharpe):
    return 0.5 * sharpe * sharpe / (sharpe * sharpe + 1)


def kelly_with_uncertainty(mu, sigma, variance):
    return mu / (mu * mu + sigma * sigma + variance)


def drawdown_limited_fraction(mu, sigma, limit, current):
    """Fraction of the optimal growth bet that keeps drawdown below ``limit``, never below 0."""
    if current >= 1:
        return 0.0
    return max(0.0, mu / sigma**2 * (1 - (1 - limit) / (1 - current)))


# --- leverage ---------------------------------------------------------------------------------------------------------
def leverage_floor(least_return, n, vol, sharpe):
    return math.sqrt(n) / vol * least_return / sharpe


def leverage_ceiling(drawdown, n, vol, sharpe, loss_prob=0.025, shock=2.0):
    room = -shock * quantile(loss_prob) - sharpe
    return math.inf if room <= 0 else math.sqrt(n) / vol * drawdown / room


def leverage_band(least_return, drawdown, n, vol, sharpe, loss_prob=0.025, shock=2.0):
    lo, hi = leverage_floor(least_return, n, vol, sharpe), leverage_ceiling(drawdown, n, vol, sharpe, loss_prob, shock)
    return lo, hi, lo <= hi


def market_variance_share(sharpe, market):
    return 1 / (1 + (sharpe / market) ** 2)


def market_gmv_share(sharpe, market, vol, market_vol):
    return 1 / (1 + sharpe / market * market_vol / vol)


def single_stock_cap(ratio, n):
    return ratio * ratio / n


def single_factor_cap(worst, loss):
    return loss / abs(worst)


# --- costs ------------------------------------------------------------------------------------------------------------
def square_root_impact(sigma, share, c=1.0):
    return c * sigma * share**0.5


def power_impact(sigma, share, c=1.0, exponent=0.6):
    return c * sigma * share**exponent


def transient_impact(share, horizon, decay, c=1.0):
    """Between a trade that is slow against the book's recovery (decay) and one that is fast (horizon / 2)."""
    fast = math.exp(-horizon / decay)
    return c * share * decay * (1 - fast + fast * horizon / 2)


def slow_decay_impact(sigma, share, horizon, c=1.0):
    return 4 / 3 * c * sigma * math.sqrt(share * horizon)


def event_trade_size(alpha, volume, days, vol, c=1.0):
    return c * alpha * volume * days / (2 * vol)


# --- statistics -------------------------------------------------------------------------------------------------------
def sharpe_standard_error(sharpe, n):
    return ((1 + sharpe * sharpe / 2) / n) ** 0.5


def sharpe_interval(sharpe, n, confidence=0.95):
    h = quantile(0.5 + confidence / 2) * sharpe_standard_error(sharpe, n)
    return sharpe - h, sharpe + h


def loss_bound(sigmas, sharpe):
    return 1 / (1 + (sigmas + sharpe) ** 2)


def expected_maximum(n_trials, variance):
    """Expected largest of n independent normal trial Sharpe ratios."""
    if n_trials <= 1:
        return 0.0
    g = 0.5772156649015329
    return math.sqrt(variance) * ((1 - g) * quantile(1 - 1 / n_trials) + g * quantile(1 - 1 / (n_trials * math.e)))


def massart_bound(n, t):
    """sqrt(2 ln n) / t: the count of observations isn't under the root."""
    return math.sqrt(2 * math.log(n)) / t


def halflife_to_decay(h):
    return 0.5 ** (1 / h)


def decay_to_halflife(k):
    return -math.log(2) / math.log(k)


def edges(n, t):
    """Range of a random correlation matrix's eigenvalues."""
    q = math.sqrt(n / t)
    return (1 - q) ** 2, (1 + q) ** 2


def spike_threshold(n, t):
    return 1 + math.sqrt(n / t)


def muth_gain(ratio):
    """Weight on the past of the steady local-level filter; ratio: deviation of the noise over that of the state."""
    p = 0.5 + math.sqrt(0.25 + ratio * ratio)
    return 1 - p / (p + ratio * ratio)


def ic_to_sharpe(ic, breadth):
    return ic * math.sqrt(breadth)


def ic_to_information_ratio(ic, breadth, periods):
    return ic * math.sqrt(breadth * periods)


def ir_from_hit_rate(hit, n, periods=252.0):
    return (2 * hit - 1) * math.sqrt(periods * n)
