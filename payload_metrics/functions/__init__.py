"""Scalar rules, each as a Column builder with a driver-side twin where specs need one."""
