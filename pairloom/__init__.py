"""pairloom: labelled sequence-pair analytics as plain Spark DataFrames.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  There is no global session and no driver-side row data.
"""
