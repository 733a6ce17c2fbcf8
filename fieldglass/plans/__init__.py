"""The assessment: sheets and findings as plans over tables of a scan.

Every sheet is a function of tables (name -> DataFrame) and returns scan_id, its columns, and `place`, which gives the
order of rows within a scan. Nothing here runs a job.
"""
