"""Text of device commands to rows.

Every parser takes a DataFrame of key columns and `text`, one text a row, and returns the keys, item_ord and the fields
of a record for each record of a text. Lines and blocks are cut by regular expressions and exploded where they are:
no parser shuffles, and no text meets another one.
"""
