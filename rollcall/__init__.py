"""Rollcall: batch jobs on Spark that keep a large directory of people and places correct."""
