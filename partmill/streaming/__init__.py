"""partmill.streaming"""
