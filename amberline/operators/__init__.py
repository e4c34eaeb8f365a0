"""DataFrame -> DataFrame operators.

Unless a parameter says otherwise the panel columns are ``account_id``,
``period`` (integer, one row per account and period), ``to_npa`` (periods until
NPA, -1 for never), ``went_bad`` (0/1 label), ``labelable``, ``portfolio``,
``decision_score``. A window over one account is at most as long as the panel
has periods, so no account can make a task large.
"""
