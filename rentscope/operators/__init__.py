"""DataFrame -> DataFrame operators; they know no domain column names."""
from .medians import global_median, grouped_median, median_ratio, median_values, multi_median
from .shares import mix, ratio_of_counts, share_of_total, top_n_share
from .topk import count_in_top_k, extremes, random_sample, top_k, top_k_per_group
from .partitioning import materialize
from .windows import adjacent_step, metric_deltas, rolling_sum
from .joins import below_group_median, count_children, portfolio_sizes, with_group_stat
from .snapshots import (group_movers, latest_snapshot, movers_by_period, pending_snapshots, previous_period,
                        require_columns, snapshot, snapshot_changes, snapshot_diff, stack_snapshots)
from .reshape import compare_groups, picks_frame, pivot_wide, side_by_side, unpivot_long
from .quality import (assert_unique, count_conditions, duplicate_keys, load_checks,
                      null_profile, range_violations)
from .text import bigram_top, lexicon_rate, mean_words, word_top, words
