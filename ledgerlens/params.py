"""Every threshold the operators use, as one immutable parameter object."""
from __future__ import annotations

from dataclasses import dataclass, field

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


@dataclass(frozen=True)
class Params:
    # bank policy
    p_open_case: float = 0.30
    p_verify_below: float = 0.70
    sar_exposure: float = 1000.0
    escalate_exposure: float = 500.0
    testing_cleared: float = 100.0
    stop_high: float = 0.85
    stop_low: float = 0.15
    block_l1_max: float = 2500.0
    # episodes
    episode_gap_us: int = 48 * HOUR
    member_threshold: float = 0.35
    lookback_us: int = 10 * DAY
    thresholds: tuple = (0.2, 0.3, 0.35, 0.4, 0.5, 0.6)
    # bursts
    burst_us: int = HOUR
    burst_min: int = 3
    small_amount: float = 5.0
    follow_us: int = 24 * HOUR
    follow_amount: float = 20.0
    cap: float = 500.0
    band: float = 0.85
    min_step: float = 0.10
    min_spread: float = 5.0
    # recurring charge
    recur_tol: float = 0.02
    recur_days: tuple = (25, 35)
    recur_min: int = 2
    # rings
    ring_us: int = 30 * DAY
    ring_customers: int = 3
    ring_share: float = 0.8
    ring_score: float = 0.5
    ring_case_us: int = 150 * DAY
    # baselines
    baseline_us: int = 120 * DAY
    history_us: int = 90 * DAY
    established_us: int = 14 * DAY
    # likelihood ratios
    lr: dict = field(default_factory=lambda: {
        "structuring": 10.0, "device_ring": 10.0, "card_testing": 5.0, "customer_report": 2.0,
        "recurring": 0.2, "denied": 2.5, "confirmed": 0.25, "no_reply": 1.0, "earlier_case": 3.0})
    deny_at: float = 0.60
    confirm_below: float = 0.40
    confirm_below_report: float = 0.20
    p_floor: float = 0.02
    p_ceil: float = 0.98
    # calibrator: weights on logit(p_flag), logit(p_max), log1p(n), known; and its priors
    cal_weights: tuple = (0.2381, 0.0106, 1.1608, 1.9369)
    cal_intercept: float = 0.0
    train_prior: float = 0.905
    target_prior: float = 0.50
    # monitor
    monitor_top: int = 10
    monitor_min_score: float = 0.05
    # how many of a list a document shows; the tables keep all
    shown_sweep_cards: int = 12
    shown_ring_cards: int = 15
    shown_devices: int = 3
    shown_shared: int = 3


DEFAULT = Params()

# The driver tables hold one month of sparse events, so hour-long bursts and a $500 cap never
# occur in them; the same operators run there with wider windows and a lower cap.
TESTBED = Params(burst_us=168 * HOUR, follow_us=168 * HOUR, cap=50.0, min_spread=0.5, ring_share=0.25,
                 ring_score=0.09, sar_exposure=60.0, escalate_exposure=30.0, block_l1_max=80.0,
                 testing_cleared=25.0, member_threshold=0.15, recur_days=(1, 8), recur_tol=0.25)
