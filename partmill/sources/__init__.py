"""partmill.sources"""
