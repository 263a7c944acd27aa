"""Loopline: timetable analytics and data-quality operators on PySpark DataFrames."""
