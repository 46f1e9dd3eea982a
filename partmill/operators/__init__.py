"""partmill.operators"""
